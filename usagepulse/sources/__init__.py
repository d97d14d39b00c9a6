"""Where activity and users come from: declarations, readers, the activity fact."""
