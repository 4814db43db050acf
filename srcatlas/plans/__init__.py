"""Assembly of facts into catalogues, diagrams and documents."""
