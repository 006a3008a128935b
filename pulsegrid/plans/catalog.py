"""All query modules; importing this fills the registry."""

from . import analysis, discovery, files, labels, observations, simulation, small, spectra, training  # noqa: F401
