"""Every operator as a query over the test tables, each with its SQL twin where SQL can say it."""

from checks import evaluation, experiments, models, relational, results  # noqa: F401
from checks.registry import QUERIES, TWINS  # noqa: F401
