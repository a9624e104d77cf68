"""Column expressions: lattice, camera, geodesy and tile arithmetic."""
