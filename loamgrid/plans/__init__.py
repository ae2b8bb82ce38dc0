"""Rule registry and driver-side planning."""
