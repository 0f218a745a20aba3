"""Import every catalogue module so the registry is complete."""

from __future__ import annotations

import os

from . import (catalog_assembly, catalog_encode, catalog_features, catalog_geo,  # noqa: F401
               catalog_history, catalog_io, catalog_learner, catalog_rates)
from .catalog_full import assemble_sql, full_sql, model_input_sql
from .registry import LAZY_ORACLES, ORACLES, QUERIES, normalise_oracle

LAZY_ORACLES["features_full"] = full_sql
LAZY_ORACLES["enc_model_input"] = model_input_sql
LAZY_ORACLES["enc_assemble"] = assemble_sql

SAMPLE_DIR = "/root/testdata/sf0.001"


def all_queries():
    return dict(QUERIES)


def all_oracles(sample_dir: str = SAMPLE_DIR) -> dict[str, str]:
    """Every oracle text, normalised by the column types of the sample tables. A broken text raises."""
    if not os.path.isdir(sample_dir):
        raise FileNotFoundError(f"sample tables for the oracle texts: {sample_dir}")
    todo = ORACLES | {k: gen(sample_dir) for k, gen in LAZY_ORACLES.items()}
    return {k: normalise_oracle(sql, sample_dir) for k, sql in todo.items()}
