"""Column builders (``Column -> Column``). No Python UDFs."""

from feedlens.functions.scalars import *  # noqa: F401,F403
from feedlens.functions.analysis import *  # noqa: F401,F403
