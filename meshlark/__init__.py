"""Periodic particle systems on Spark DataFrames."""

from .functions.bspline import bspline as bspline_transfer
from .plans.energy import dispersion_energy, dispersion_energy_and_derivatives
from .plans.model import Model

__all__ = ["Model", "bspline_transfer", "dispersion_energy", "dispersion_energy_and_derivatives"]
