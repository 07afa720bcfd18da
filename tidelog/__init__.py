"""Analytics over large bodies of dated text, as Spark jobs."""
