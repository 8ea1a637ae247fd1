"""Part of burnline."""
