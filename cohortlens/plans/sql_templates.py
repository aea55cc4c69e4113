"""SQL text of ranking metrics and step-down adjustment, for callers who work on temporary views.

Equal values are counted first. The counts are cut into bands of the value, and windows run over the ties of one band and over
the at most ``BANDS`` bands of a key, never over a whole key. Values outside the given range belong to the outer bands.
Null keys are keys of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

BANDS = 256


def _on(a: str, b: str, names: Sequence[str]) -> str:
    return " AND ".join(f"{a}.{n} <=> {b}.{n}" for n in names) or "true"


def _list(names: Sequence[str], alias: str = "") -> str:
    return "".join(f"{alias}.{n}, " if alias else f"{n}, " for n in names)


def _band(value: str, low: float, high: float) -> str:
    return f"CAST(least({BANDS - 1}, greatest(0, floor(({value} - {low!r}D) / {float(high - low)!r}D * {BANDS}))) AS INT)"


def ranking_sql(view: str, keys: Sequence[str], score: str = "score", label: str = "label", low: float = 0.0, high: float = 1.0) -> str:
    """(keys, n, n_pos, ap, auc) of finite scores; ``ap`` and ``auc`` are null where they are not defined."""
    k, part = _list(keys), ", ".join([*keys, "_b"])
    whole = f"PARTITION BY {', '.join(keys)}" if keys else ""
    grouped = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
WITH ties AS (SELECT {k}{score} AS s, {_band(score, low, high)} AS _b, count(*) AS n, sum(CAST({label} AS INT)) AS pos FROM {view} GROUP BY {k}{score}),
bands AS (SELECT {part}, sum(n) AS bn, sum(pos) AS bp FROM ties GROUP BY {part}),
above AS (SELECT {part}, (sum(bn) OVER (down)) - bn AS an, (sum(bp) OVER (down)) - bp AS ap, sum(bn) OVER everything AS tn, sum(bp) OVER everything AS tp
          FROM bands WINDOW down AS ({whole} ORDER BY _b DESC), everything AS ({whole})),
cum AS (SELECT {_list(keys, 't')}t.n, t.pos, tn, tp, an + (sum(t.n) OVER (down)) AS cn, ap + (sum(t.pos) OVER (down)) AS cp
        FROM ties t JOIN above a ON {_on('t', 'a', [*keys, '_b'])} WINDOW down AS (PARTITION BY {', '.join(f't.{c}' for c in [*keys, '_b'])} ORDER BY t.s DESC))
SELECT {k}max(tn) AS n, max(tp) AS n_pos,
       try_divide(sum(pos * cp / cn), max(tp)) AS ap,
       try_divide(sum(CAST(pos * (2 * ((tn - tp) - (cn - cp)) + (n - pos)) AS DOUBLE)), 2.0D * max(tp) * (max(tn) - max(tp))) AS auc
FROM cum {grouped}"""


def holm_sql(view: str, keys: Sequence[str], p: str = "p_value") -> str:
    """All rows of the view with ``p_holm``, the step-down adjustment inside each family; null where p is null or not finite."""
    k, part = _list(keys), ", ".join([*keys, "_b"])
    whole = f"PARTITION BY {', '.join(keys)}" if keys else ""
    band = f"PARTITION BY {', '.join(f't.{c}' for c in [*keys, '_b'])}"
    return f"""
WITH ties AS (SELECT {k}{p} AS p, {_band(p, 0.0, 1.0)} AS _b, count(*) AS n FROM {view} WHERE {p} IS NOT NULL AND NOT isnan({p}) AND abs({p}) < double('inf') GROUP BY {k}{p}),
bands AS (SELECT {part}, sum(n) AS bn FROM ties GROUP BY {part}),
below AS (SELECT {part}, sum(bn) OVER ({whole} ORDER BY _b) - bn AS under, sum(bn) OVER ({whole} {'' if whole else 'ORDER BY NULL ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'}) AS m FROM bands),
steps AS (SELECT {_list(keys, 't')}t._b, t.p, least(1.0D, (m - under - (sum(t.n) OVER ({band} ORDER BY t.p) - t.n)) * t.p) AS v FROM ties t JOIN below o ON {_on('t', 'o', [*keys, '_b'])}),
tops AS (SELECT {part}, max(max(v)) OVER ({whole} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps GROUP BY {part}),
adjusted AS (SELECT {_list(keys, 't')}t.p, greatest(before, max(t.v) OVER ({band} ORDER BY t.p)) AS p_holm FROM steps t JOIN tops o ON {_on('t', 'o', [*keys, '_b'])})
SELECT src.*, adjusted.p_holm FROM {view} src LEFT JOIN adjusted ON {_on('src', 'adjusted', keys)} AND src.{p} = adjusted.p"""
