"""Operators: DataFrame in, DataFrame out; nothing here runs an action unless it says so."""
