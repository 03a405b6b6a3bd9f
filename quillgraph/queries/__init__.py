"""Named queries over the driver's tables; importing the modules registers them."""

from quillgraph.queries import facts, graphs, knowledge, relational, workspace  # noqa: F401
