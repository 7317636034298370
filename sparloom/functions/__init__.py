"""Column functions: text, typed parsing, JSON and XML builders."""
