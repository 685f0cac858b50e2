"""Part of quire; see the package README."""
