"""Named relational, ordered-state and data-evolution queries."""
