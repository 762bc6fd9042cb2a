"""Where results go: verdicts, merged contacts, report tables. Each writes one folder a table, from all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_verdicts(ledger_rows: DataFrame, path: str) -> None:
    """The gate's ledger rows as CSV, a folder for each decision; the findings, in their order, as one text."""
    rows = ledger_rows.withColumn("findings", F.array_join("findings", "; "))
    rows.write.partitionBy("decision").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_merged(clean: DataFrame, log: DataFrame, path: str) -> None:
    """Clean contacts and the log of what was merged into them, as CSV in `clean` and `log`."""
    for name, df in (("clean", clean), ("log", log)):
        df.write.csv(f"{path}/{name}", header=True, quote='"', escape='"', emptyValue="")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Report, digest and policy tables as JSON lines, a folder each."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
