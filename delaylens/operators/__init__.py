"""Operators: DataFrame -> DataFrame functions composable with df.transform."""
