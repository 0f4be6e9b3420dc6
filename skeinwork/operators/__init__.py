"""The relational operators."""

from .aggregation import *  # noqa: F403
from .control import Interrupt, interruptible, profile, spy  # noqa: F401
from .joins import *  # noqa: F403
from .ordinals import changed, running_min_with_flush, running_sum, sequence, smudge, smudge_if, with_ordinal  # noqa: F401
from .relational import *  # noqa: F403
