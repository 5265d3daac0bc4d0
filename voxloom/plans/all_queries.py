"""Imports every module that registers queries."""

from . import search_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
from . import sequence_queries  # noqa: F401, E402
from . import table_queries  # noqa: F401, E402
from . import transcript_queries  # noqa: F401, E402
from . import more_queries  # noqa: F401, E402
from . import engine_queries  # noqa: F401, E402
from . import episode_queries  # noqa: F401, E402
