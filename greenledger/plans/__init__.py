"""The domain over the test tables and the registered queries with their SQL twins."""
