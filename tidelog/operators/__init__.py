"""Plans from DataFrames to DataFrames: last-writer-wins resolution, tiers, manifests and replicated logs."""
