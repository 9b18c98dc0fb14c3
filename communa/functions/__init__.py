"""Column functions: gains, softmax weights and seeded uniforms."""
