"""Where events come from: files with fixed schemas, generated ticks, and views of the test tables."""
