"""Column builders: addressed draws, samplers, strings, numbers and ids."""
