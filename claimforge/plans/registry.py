"""Query registry: importing this module registers every key."""

from claimforge.plans.base import ORACLE, QUERIES  # noqa: F401
from claimforge.plans import q_corpus  # noqa: F401
from claimforge.plans import q_eval  # noqa: F401
from claimforge.plans import q_runs  # noqa: F401
from claimforge.plans import q_io  # noqa: F401
from claimforge.plans import q_ablation  # noqa: F401
