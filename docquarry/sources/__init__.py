"""Document sources: everything that produces a ``sources`` DataFrame."""
