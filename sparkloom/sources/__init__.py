"""Edge lists, vertex columns, prepared graphs and run logs."""
