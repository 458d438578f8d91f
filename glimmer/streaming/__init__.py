"""Job events and early segments as structured streams."""
