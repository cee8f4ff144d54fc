"""Part of the workbench."""
