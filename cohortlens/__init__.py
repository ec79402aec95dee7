"""Panel risk analytics as Spark DataFrame operators."""

from cohortlens.spec import Feature, PanelSpec

__all__ = ["Feature", "PanelSpec"]
