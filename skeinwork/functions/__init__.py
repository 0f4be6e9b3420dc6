"""All expression builders under one roof."""

from .arithmetic import *  # noqa: F403
from .dates import *  # noqa: F403
from .elementary import *  # noqa: F403
from .hashing import Fingerprint, Hash  # noqa: F401
from .maths import *  # noqa: F403
from .regexps import RegexpExtract, RegexpFullMatch, RegexpPartialMatch, RegexpReplace, RegexpRewrite  # noqa: F401
from .strings import *  # noqa: F403
from .terminals import *  # noqa: F403
from .dates import ConstDateTime  # noqa: F401, E402
