"""Imports every module of queries."""

from tessera.plans import relational  # noqa: F401
from tessera.plans import evaluation  # noqa: F401
from tessera.plans import patches  # noqa: F401
from tessera.plans import extras  # noqa: F401
from tessera.plans import closure  # noqa: F401
from tessera.plans import windows  # noqa: F401
