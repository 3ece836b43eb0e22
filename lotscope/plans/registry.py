"""Every registered query of the engine with its DuckDB SQL."""

from __future__ import annotations

from lotscope.plans import appraisal, market, reading, reports, texts

QUERIES: dict = {**market.QUERIES, **appraisal.QUERIES, **texts.QUERIES, **reading.QUERIES, **reports.QUERIES}
SQL: dict[str, str] = {**market.SQL, **appraisal.SQL, **texts.SQL, **reading.SQL, **reports.SQL}
