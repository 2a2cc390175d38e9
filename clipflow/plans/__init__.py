"""Queries over the driver's tables. Importing this package registers them."""

from clipflow.plans import calibration, crops, io, landmarks, runs, segmentation, streams, text  # noqa: F401
from clipflow.plans.registry import ORACLES, QUERIES  # noqa: F401
