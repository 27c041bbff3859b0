"""Board, move, tag and rating analytics as plain DataFrame-to-DataFrame functions on Spark."""
