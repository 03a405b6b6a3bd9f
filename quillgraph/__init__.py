"""Code-knowledge analytics as Spark jobs: facts, typed graph, ranked evidence."""
