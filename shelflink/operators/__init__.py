"""DataFrame operators: joins that survive hot keys, extraction, blocking, scoring."""
