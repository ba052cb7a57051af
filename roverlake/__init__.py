"""Fleet telemetry analytics as Spark DataFrame operators.

Sub-packages:
  sources    -- table loading, adapters from the test tables, landing/stream sources, sinks
  functions  -- column-level expressions (JSON access, time formats, sensor reductions)
  operators  -- DataFrame -> DataFrame operators (envelope, routing, roll-ups, state, edge nodes)
  plans      -- named query plans used by the driver contract and the benchmark
  streaming  -- Structured Streaming jobs that reuse the batch operators
"""

from roverlake.session import configure, get_session

__all__ = ["configure", "get_session"]
