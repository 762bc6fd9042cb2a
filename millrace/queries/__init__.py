"""Registered queries of the library's operators, and the SQL that each is compared with."""

from millrace.queries import basics, copygate, entity, experiments, leads, ledger, mix, runs

MODULES = (ledger, runs, leads, entity, copygate, experiments, mix, basics)


def collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(module, name))
    return out
