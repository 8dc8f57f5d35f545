"""DataFrame operators. Each is a plain function from DataFrame to DataFrame."""
