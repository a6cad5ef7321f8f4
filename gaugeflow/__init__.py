"""gaugeflow: station time series and training-data preparation on Spark DataFrames."""

from gaugeflow.functions.durations import parse_duration_us
from gaugeflow.operators.resample import resample
from gaugeflow.sources.dataset import build_local, merge_dataset
from gaugeflow.sources.publish import Catalogue, build_and_publish, update_and_publish

__version__ = "0.2.0"
__all__ = [
    "Catalogue",
    "build_and_publish",
    "build_local",
    "merge_dataset",
    "parse_duration_us",
    "resample",
    "update_and_publish",
]
