"""modelkeel: the data side of a continuous-training loop as Spark jobs."""

from modelkeel.spec import ColumnCheck, ModelSpec, UseCase, load_use_case

__all__ = ["ColumnCheck", "ModelSpec", "UseCase", "load_use_case"]
