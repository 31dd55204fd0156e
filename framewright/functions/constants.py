"""Constants that change answers, in one place."""

#: Gas constant (kJ/mol/K), floors, tolerances and defaults.
R_KJ = 0.00831446261815324
TINY = 1e-12
ABS_TOL = 1e-6
REL_TOL = 1e-8
DIRICHLET_ALPHA = 1e-3
LEAST_RATE = 1e-6


def kt(temperature: float = 300.0) -> float:
    """Thermal energy in kJ/mol; the temperature must be positive."""
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    return R_KJ * temperature
