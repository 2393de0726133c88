"""annolake: DataFrame operators for building and auditing labelled text datasets on Spark."""
