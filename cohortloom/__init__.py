"""Clinical evidence and cohort analytics as Spark DataFrame transformations."""

from .config import TrialConfig
from .definitions import Definition, shipped_definitions
from .plans.trial import Trial
from .sources.snapshot import Snapshot

__all__ = ["Definition", "Snapshot", "Trial", "TrialConfig", "shipped_definitions"]
