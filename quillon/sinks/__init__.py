"""Files that runs leave: canonical lines, sheets, manifests, state."""
