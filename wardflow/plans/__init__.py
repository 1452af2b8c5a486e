"""End-to-end plans (audit, training, evaluation) and the registered queries."""

from . import q_corpus, q_findings, q_flows, q_models  # noqa: F401
from .registry import REGISTRY  # noqa: F401
