"""Part of studyloom."""
