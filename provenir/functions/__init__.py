"""Part of the provenance analytics engine."""
