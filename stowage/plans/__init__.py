"""Shapes of plan shared by the operators: sliced ordering and spread joins."""
