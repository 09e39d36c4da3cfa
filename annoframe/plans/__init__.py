"""Queries over the driver tables, each with its SQL where one exists."""

from annoframe.plans import (  # noqa: F401  (importing registers the queries)
    audits,
    clusters,
    converted,
    evaluation,
    feature_sets,
    model_runs,
    profiles,
    rankings,
    run_statistics,
    split_sets,
    storage,
    time_forward,
)
