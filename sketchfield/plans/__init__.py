"""Driver-side planning: sizes, slices, tree nodes and validated configurations. No Spark job runs here."""
