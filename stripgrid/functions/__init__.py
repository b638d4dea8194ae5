"""Small helpers used inside plans: column expressions, reducers, Arrow/NumPy conversion, dense algebra."""
