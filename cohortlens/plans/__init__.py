"""End-to-end plans and the views of the input tables they run on."""
