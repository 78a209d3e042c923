"""Analytics over wikitext dumps and text columns on Spark."""
