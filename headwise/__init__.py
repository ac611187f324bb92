"""Transit punctuality analytics as DataFrame-to-DataFrame functions.

Sub-packages
------------
functions   Column builders (time, statistics, predicates, keys, geometry)
sources     readers and writers (timetable CSV, poll archive, table sinks)
operators   DataFrame operators (flatten, match, collapse, roll up, serve, ...)
plans       compositions: published documents, jobs, the query catalogue
streaming   Structured Streaming versions of the same work
"""
