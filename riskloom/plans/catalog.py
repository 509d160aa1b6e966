"""All registered queries (importing the modules fills the registry)."""

from riskloom.plans import queries_core  # noqa: F401
from riskloom.plans import queries_sources  # noqa: F401
from riskloom.plans import queries_ml  # noqa: F401
from riskloom.plans import queries_stream  # noqa: F401
from riskloom.plans import queries_fixed  # noqa: F401
from riskloom.plans.registry import REGISTRY  # noqa: F401
