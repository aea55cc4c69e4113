"""Column-level building blocks: scalar rules, seeded draws, digests and registries."""
