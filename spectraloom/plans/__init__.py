"""The registered queries; importing modelling, nonlinear, validation and workbench adds their own to those of registry."""

from spectraloom.plans import modelling, nonlinear, registry, validation  # noqa: F401
from spectraloom.plans import workbench  # noqa: F401
