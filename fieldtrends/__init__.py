"""fieldtrends: population trends from field checklists, as Spark jobs."""
