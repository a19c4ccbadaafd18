from tesselark.plans.jobs import main

main()
