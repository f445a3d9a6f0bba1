"""What a person or a program talks to: projects, tools, agents, protocol servers, a command line. Thin, on the driver, over the operators."""
