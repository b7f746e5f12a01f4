"""tidewake: DataFrame operators for event, table, text and time-series analytics on Spark.

Every operator is a function from DataFrame to DataFrame.  Nothing here starts a session; see
``tidewake.session`` for the settings the operators expect.
"""
