from corpuslab.plans import corpus, duplicates, evaluation, files, scaling  # noqa: F401
from corpuslab.plans.registry import ORACLES, QUERIES  # noqa: F401
