"""Models fitted on the whole panel of series with the cluster's own learners."""
