"""All registered queries."""

from checks import governance, publishing, scanning, site  # noqa: F401
from checks.base import CHECKS  # noqa: F401
