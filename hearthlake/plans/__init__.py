"""Queries built from the operators."""


def load() -> None:
    """Fills the catalog."""
    from hearthlake.plans import energy_queries, job_queries, room_queries, telemetry_queries, template_queries  # noqa: F401
