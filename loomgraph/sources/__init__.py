"""Where facts come from: stored tables, projections of other tables, files and reports."""
