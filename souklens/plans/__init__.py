"""Named datasets: access, consolidation, facts, dimensions, reports and the published catalogue.

Each is a function from frames to a frame. Nothing here runs a job, except where a docstring says
that an intermediate table is written.
"""
