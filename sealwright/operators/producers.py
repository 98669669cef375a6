"""Evidence producers and output validators that users plug in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding, union

ARTIFACT_COLUMNS = ("producer", "scope_id", "path", "kind", "sha256", "size")
Normalize = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass
class ProducerRegistry:
    """Named functions from raw tables to artifact rows, joined into one table."""

    producers: dict[str, Normalize] = field(default_factory=dict)

    def register_producer(self, name: str, normalize: Normalize) -> None:
        """``normalize`` returns ``(scope_id, path, kind, sha256, size)`` rows."""
        if name in self.producers:
            raise ValueError(f"producer {name} is registered twice")
        self.producers[name] = normalize

    def collect(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Artifacts of all producers; evaluated where the tables are."""
        parts = [
            normalize(tables).select(F.lit(name).alias("producer"), *ARTIFACT_COLUMNS[1:])
            for name, normalize in self.producers.items()
        ]
        return union(*parts)


Validator = Callable[[Column], Column]


def output_findings(output: DataFrame, scope: str, validators: Mapping[str, Validator], content: str = "content") -> DataFrame:
    """Outputs ``(scope, path, kind, content)`` their kind's validator rejects.

    A validator maps the content column to a boolean column, built in or a batch
    function; null counts as rejected, and so does a kind's failure to evaluate
    when its expression uses the ``try_`` functions.  Kinds without validator pass.
    """
    parts = []
    for kind, validator in validators.items():
        rows = output.filter(F.col("kind") == kind)
        rejected = rows.filter(~F.coalesce(validator(F.col(content)), F.lit(False)))
        parts.append(finding(rejected, scope, 0, "process.output_malformed", F.col("path"), kind))
    return union(*parts)


def guarded(check: Callable[[bytes | str], bool]) -> Validator:
    """A per-value predicate as a batch validator; an exception counts as false."""

    def run(batches):
        import pandas as pd

        def safe(value) -> bool:
            try:
                return value is not None and bool(check(value))
            except Exception:  # noqa: BLE001 - a failing predicate rejects the output
                return False

        for batch in batches:
            yield pd.Series([safe(value) for value in batch], dtype="bool")

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "boolean")
    return lambda content: udf(content)
