"""Adding an edition to the pool.

There are no streaming operators: editions arrive years apart and are read whole, so a new one is
a batch append of its own partition.
"""
