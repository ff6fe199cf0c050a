"""Models; importing the package registers the built-in ones."""

from emulake.models import ensemble, forest, fourier_bayes, linear, mlp  # noqa: F401
from emulake.models.base import REGISTRY, Model  # noqa: F401
