"""Table operators: predicates, joins, aggregations, windows, sets, writes,
search, text analytics, topic models and the graph."""
