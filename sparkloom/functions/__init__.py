"""Column functions with the engine's semantics, all built on Spark's own expressions where these exist."""

from sparkloom.functions.aggregates import *  # noqa: F403
from sparkloom.functions.binary import *  # noqa: F403
from sparkloom.functions.lists import *  # noqa: F403
from sparkloom.functions.media import *  # noqa: F403
from sparkloom.functions.misc import *  # noqa: F403
from sparkloom.functions.models import *  # noqa: F403
from sparkloom.functions.numeric import *  # noqa: F403
from sparkloom.functions.partitioning import *  # noqa: F403
from sparkloom.functions.recordings import *  # noqa: F403
from sparkloom.functions.similarity import *  # noqa: F403
from sparkloom.functions.strings import *  # noqa: F403
from sparkloom.functions.temporal import *  # noqa: F403
from sparkloom.functions.windows import *  # noqa: F403
