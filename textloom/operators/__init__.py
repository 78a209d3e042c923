"""DataFrame operators: articles, sections, lookups, category graph, statistics."""
