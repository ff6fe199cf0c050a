"""Importing this package registers every query."""

from emulake.plans.catalog import accuracy, campaigns, files_and_streams, models_and_runs, monitoring, nested_records, profiling, splits  # noqa: F401
from emulake.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
