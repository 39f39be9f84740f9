"""Where data sets, models and prediction logs live, and URI columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leaf names inside a run folder.
RAW, TRAIN, HOLDOUT, REFERENCE, MODEL = "raw", "train", "holdout", "reference", "model"
#: Object-store URI pattern (bucket, key).
OBJECT_URI = r"^s3://([^/]*)/?(.*)$"


@dataclass(frozen=True)
class Layout:
    """Path builder for one use case under one root."""

    root: str
    use_case: str

    def dataset(self, model: str, run_id: str, name: str) -> str:
        return f"{self.root}/datasets/{self.use_case}/{model}/{run_id}/{name}"

    def serving(self, model: str, version: int | str) -> str:
        return f"{self.root}/models/{self.use_case}/{model}/v{version}"

    def prediction_log(self) -> str:
        """Root of the log; partitioned by ``use_case, model, date`` below it."""
        return f"{self.root}/predictions"

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"


def parse_object_uri(uri: str) -> tuple[str, str]:
    """Bucket and key of one URI on the driver; anything but ``s3://`` is an error."""
    scheme, sep, rest = uri.partition("://")
    if scheme != "s3" or not sep:
        raise ValueError(f"not an s3 uri: {uri}")
    bucket, _, key = rest.partition("/")
    return bucket, key


def uri_bucket(uri: Column | str) -> Column:
    return F.regexp_extract(uri, OBJECT_URI, 1)


def uri_key(uri: Column | str) -> Column:
    return F.regexp_extract(uri, OBJECT_URI, 2)
