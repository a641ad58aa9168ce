"""Where tables come from and go to: scans, the generation store, sinks."""
