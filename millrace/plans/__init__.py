"""All registered queries: name to (callable, SQL or None)."""

from __future__ import annotations

from . import answers, casework, catalog, evaluation, exchange, joining, manifests, media, planning, records, sampling, verdicts

REGISTRY = {**evaluation.QUERIES, **joining.QUERIES, **sampling.QUERIES, **media.QUERIES, **planning.QUERIES, **answers.QUERIES, **catalog.QUERIES, **casework.QUERIES, **records.QUERIES, **manifests.QUERIES, **verdicts.QUERIES, **exchange.QUERIES}
