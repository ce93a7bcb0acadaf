"""Answer a provider data request: gate, filter, project, sample, write, summarise."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quayside.operators.predicates import apply_filters, project
from quayside.operators.sampling import sample_with_replacement
from quayside.sources.readers import STANDARD_READERS, Readers
from quayside.sources.sinks import write_extract


class Extractor(ABC):
    """What a provider implements to serve data requests."""

    @abstractmethod
    def extract(
        self,
        features: Sequence[Mapping],
        label: Mapping | None,
        filters: Mapping | None = None,
        sample_limit: Mapping | None = None,
        qod: Mapping | None = None,
    ) -> DataFrame: ...


class TableExtractor(Extractor):
    """Serves requests from a DataFrame; ``key`` identifies its rows for the seeded sample."""

    def __init__(self, source: DataFrame, key: Sequence[str], seed: int = 42):
        self.source, self.key, self.seed = source, list(key), seed

    def extract(self, features, label, filters=None, sample_limit=None, qod=None) -> DataFrame:
        """Filter, then sample, then project: the sample needs the key, and projection commutes with it."""
        rows = apply_filters(self.source, filters)
        columns = project(rows, features, label).columns
        if sample_limit and sample_limit["method"].lower() == "random":
            narrow = rows.select(*dict.fromkeys([*columns, *self.key]))
            rows = sample_with_replacement(narrow, int(sample_limit["number"]), self.key, self.seed)
        return rows.select(*columns)


def check_request(request: Mapping, owner_id: str, dataset_id: str) -> None:
    if request["owner_id"] != owner_id or request["dataset_id"] != dataset_id:
        raise PermissionError("the request is for another owner or dataset")


def summarise(df: DataFrame) -> DataFrame:
    """Rows and columns of a dataset."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def serve(
    spark: SparkSession,
    request: Mapping,
    conf: Mapping,
    key: Sequence[str],
    readers: Readers = STANDARD_READERS,
    request_id: str | None = None,
) -> dict:
    """Run one request end to end and return the response record. Rows are counted while they are written."""
    check_request(request, conf["owner_id"], conf["dataset_id"])
    access = request["access_info"]
    source = readers.read(spark, access.get("format", "csv"), {**access, "schema": conf.get("schema")})
    extracted = TableExtractor(source, key).extract(
        request["features"], request.get("label"), request.get("filters"), request.get("sample_limit")
    )
    counter = Observation()
    observed = extracted.observe(counter, F.count(F.lit(1)).alias("rows"))
    path = write_extract(observed, conf["dest_path"], request["dataset_id"], request_id or uuid.uuid4().hex)
    return {
        "dataset_id": request["dataset_id"],
        "data_summary": {"columns": len(extracted.columns), "rows": counter.get["rows"]},
        "read_info": {"method": conf.get("method", "local"), "location": path, "reader_module": conf.get("reader_module")},
    }
