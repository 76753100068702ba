"""Operators: DataFrame -> DataFrame, every moment an explicit argument, every tie broken totally."""
