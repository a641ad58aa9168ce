"""Retrieval plans and the driver-side code that turns a question into DataFrame operators."""
