"""chronosift: event-log and timeline analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from chronosift.plans.event_table import EventTable
from chronosift.session import build_session
from chronosift.sources.open import open_events

__all__ = ["EventTable", "build_session", "open_events"]

# Functions that run on the workers travel by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
